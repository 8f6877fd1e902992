"""Token files, Merkle manifest and tokenizer alignment against plain code."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cartonscope.llm import alignment as AL
from cartonscope.llm import merkle, queries
from cartonscope.llm import token_files as TF
from cartonscope.llm.tokens import TextEncoder, load_tokenizer, runs

#: Texts in which white space, marks, control strings and scripts meet.
AWKWARD = ["a b", " a", "a ", "  a  b ", "a  b", "a  b", "a 　b", "e ́a", "a\t b\r\n c", "don't I'll 's", "<|endoftext|> x<|startoftext|>y", "a▁b c",
           "<0x41> <s> </s>", "漢字 仮名 é Å", "\U0001f600 \U0001f468‍\U0001f469", "12 345 6,7", "\x00 \x1c \x85 x", "xyz" * 700, "ΣΑΣ ΑΣ", "-- -.- ...",
           "a \x1cb", "  a  b", "ſ ß İ I"]


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(11)
    letters = ["a", "B", " ", " ", "  ", "\n", "\t", ".", "'s", "7", "é", "́", " ", "漢", "<|endoftext|>", "▁", "_"]
    return [*AWKWARD, *["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300)]]


# ---- token files -----------------------------------------------------------------------------

WORDS = queries.vocabulary("word_bpe_49k.json")


def plain_ids(texts):
    tokenizer = load_tokenizer(WORDS)
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_of_words_are_those_of_whole_texts(texts):
    for most in (1 << 20, 64):
        encoder = TextEncoder(WORDS, 2, True, most)
        for at in range(0, len(texts), 50):
            some = texts[at:at + 50]
            ids, counts = encoder(pa.array(some))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain_ids(some)
    ids, counts = TextEncoder(WORDS, 2, False)(pa.array(["", None, "a b"]))
    assert counts.tolist() == [1, 1, 3] and ids.tolist() == sum(plain_ids(["", "", "a b"]), [])


def test_runs():
    assert runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert len(runs(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_token_files_read_back(spark, docs, rows):
    folder = TF.new_folder(spark)
    manifest = TF.write(docs, folder, WORDS, 2, length=64, rows=4, by_word=True, shards=3)
    got = [tuple(r) for r in TF.documents(manifest, folder).collect()]
    ids = dict(zip([t for _, t, *_ in rows], plain_ids([t for _, t, *_ in rows])))
    # Rows of one id stand in some order; starts follow it.
    order = sorted(got, key=lambda r: r[1])
    assert [r[0] is not None for r in order] == sorted(r[0] is not None for r in order)
    assert [r[0] for r in order if r[0] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r[1] for r in order] == (np.cumsum([r[2] for r in order]) - [r[2] for r in order]).tolist()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(ids[t]), crc(ids[t])) for i, t, *_ in rows)
    # Random access: sequence by sequence the shards give all ids in order, and only the last of a shard has padding.
    store, _ = fs.FileSystem.from_uri(folder)
    stream, shards = [], manifest.orderBy("shard").collect()
    for m in shards:
        shard = TF.Shard(store, m.sequences)
        some = [shard.sequence(i) for i in range(len(shard))]
        assert all(len(x) == 64 and len(mask) == 64 for x, mask in some) and all(mask.all() for _, mask in some[:-1])
        assert not shard.sequence(0)[0].flags.owndata
        stream += np.concatenate([x[mask] for x, mask in some]).tolist()
        assert shard.reader.schema.field("input_ids").type == pa.list_(pa.uint16(), 64)
    assert len(shards) == 3 and crc(stream) == crc([t for r in order for t in next(ids[x] for i, x, *_ in rows if i == r[0] and (len(ids[x]), crc(ids[x])) == r[2:])])


def test_token_files_do_not_hang_on_the_cut(spark, docs):
    found = []
    for shards, length, rows in ((1, 16, 1), (7, 2048, 128)):
        folder = TF.new_folder(spark)
        found.append(Counter(map(tuple, TF.documents(TF.write(docs, folder, WORDS, 2, length, rows, True, shards), folder).collect())))
    assert found[0] == found[1]


def test_one_id_fills_several_shards(spark):
    folder = TF.new_folder(spark)
    same = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    manifest = TF.write(same, folder, WORDS, 2, by_word=True, shards=4)
    assert manifest.count() == 4 and TF.documents(manifest, folder).select("ids_crc32").distinct().count() == 1


def test_token_files_of_nothing(spark, no_docs):
    folder = TF.new_folder(spark)
    manifest = TF.write(no_docs, folder, WORDS, 2, by_word=True)
    assert manifest.count() == 0 and TF.documents(manifest, folder).collect() == []


# ---- Merkle manifest -------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def tree(nodes):
    """Root, and for every node its siblings on the way up: side and digest, or neither."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, a in zip(paths, at):
            b = a ^ 1
            path.append(("", "") if b >= len(nodes) else ("left" if b < a else "right", nodes[b]))
        nodes, at = [digest(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)], [a // 2 for a in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    groups = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for g in
              sorted(groups, key=lambda g: (g is not None, (g or "").encode()))}
    trees = {g: tree([leaf_of(r) for r in found]) for g, found in groups.items()}
    root, above = tree([t[0] for t in trees.values()])
    out = []
    for (g, found), up in zip(groups.items(), above):
        for row, path in zip(found, trees[g][1]):
            seen = dict(row)
            if row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                seen["n_chars"] += 1
            node = leaf_of(seen)
            for side, other in path + up:
                node = digest(other, node) if side == "left" else digest(node, other)
            out.append((row["doc_id"], leaf_of(row), trees[g][0], root, digest(*[o for _, o in path + up]), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("block", [2, 4, 512])
def test_manifest_equals_a_plain_tree(docs, monkeypatch, block):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], block))
    got = Counter(map(tuple, queries.merkle_digests(docs).collect()))
    assert got == plain_manifest([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_every_row_a_group_and_one_row(spark, docs):
    single = docs.limit(1)
    assert Counter(map(tuple, queries.merkle_digests(single).collect())) == plain_manifest([r.asDict() for r in single.collect()])
    alone = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("lang", F.concat(F.lit("é"), F.col("doc_id").cast("string")))
    assert Counter(map(tuple, queries.merkle_digests(alone).collect())) == plain_manifest([r.asDict() for r in alone.collect()])


def test_manifest_of_nothing(no_docs):
    assert queries.merkle_digests(no_docs).collect() == []


def test_manifest_paths_name_sides(docs):
    found = merkle.manifest(docs).select("leaf", "root", "path").collect()
    for r in found:
        node = r.leaf
        for step in r.path:
            assert not (step.left and step.right)
            node = digest(step.left, node, step.right)
        assert node == r.root


# ---- alignment -------------------------------------------------------------------------------

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


class Plain:
    """Whole texts by both tokenizers, walked token by token."""

    def __init__(self):
        import sentencepiece
        self.a, self.b = load_tokenizer(A, plain_specials=True), sentencepiece.SentencePieceProcessor(model_file=B)
        self.alphabet = AL.byte_alphabet()

    def tokens(self, text):
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        found, mine, theirs, x, y = [], [], [], 0, 0
        a, b = map(list, self.tokens(text)) if text else ([], [])
        a, b = a[::-1], b[::-1]
        while a or b:
            side, ids = (a, mine) if x <= y else (b, theirs)
            i, raw = side.pop()
            ids.append(i)
            x, y = (x + len(raw), y) if side is a else (x, y + len(raw))
            if x == y:
                found.append((mine, theirs))
                mine, theirs = [], []
        return found

    def rows(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        links = [Counter((x, y) for g, h in groups for x in g for y in h) for _, groups in found]
        docs = Counter(pair for some in links for pair in some)
        most = Counter()
        for (x, _), n in docs.items():
            most[x] = max(most[x], n)
        text = lambda groups: ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        return Counter((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(some.values()),
                        sum(n for p, n in some.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in some.items()),
                        hashlib.sha256(text(groups).encode()).hexdigest() if groups else "") for (i, groups), some in zip(found, links))


def test_alphabet_is_that_of_the_vocabulary():
    alphabet = AL.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256))
    assert all(c in alphabet for entry in load_tokenizer(A).get_vocab(with_added_tokens=False) for c in entry)


def test_intervals_coalesce():
    a, b = AL.groups(np.array([0, 2, 5, 6]), np.array([2, 5, 6, 9]), np.array([0, 1, 5]), np.array([1, 5, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1]


@pytest.mark.parametrize("block_bytes, most", [(AL.BLOCK_BYTES, AL.REMEMBERED), (200, 64)])
def test_alignment_of_awkward_texts(spark, texts, block_bytes, most):
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "a b"), (1, None), (5, ""), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("pair", F.lit("extra")).withColumn("block", F.lit(1))
    got = Counter(map(tuple, AL.align(df, A, B, block_bytes=block_bytes, most=most).collect()))
    assert got == Plain().rows(rows)
    assert any(r[-1] == "" and r[0] is not None for r in got)


def test_alignment_of_documents(docs, rows):
    assert Counter(map(tuple, AL.align(docs, A, B).collect())) == Plain().rows([r[:2] for r in rows])


def test_alignment_of_nothing(no_docs):
    assert AL.align(no_docs, A, B).collect() == []


def test_pair_counts_mark_the_best(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the")], "doc_id long, text string")
    found = AL.pair_counts(AL.aligned_blocks(df, A, B)).collect()
    assert max(r["count"] for r in found) == 3 and all(r.best for r in found)
