"""Token ids: the library's ids, exact round trips, select."""

import base64
import random

import numpy as np
import pytest
import tiktoken

from lexforge.llm import tokens


@pytest.fixture(scope="module")
def raw():
    with open(tokens.VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(raw), special_tokens={})


ODD = [
    "", " ", "  ", "a", " a", "  a", "a ", "a  ", "a\n\nb", "\n a", "a\t b", "it's we're they'll I'd don't o'clock 'sun ''s '' s", "x 's", "'", "''", "'re", "'r", "'l 'll 'lll",
    "1a2 33b ,,, .a .1", "é à l'été", "日本語 テキスト", "a b   c", "😀😀 😀a", "a\r\n\r\nb", " x", "<|endoftext|>", "can't\nwon't", "'S 'T", "don't" * 3, "'ſ",
]


def encode(raw, texts):
    enc = tokens.Encoder(raw)
    parts = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ids, per = enc.encode(np.frombuffer(b"".join(parts), np.uint8), offs)
    return [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]


def test_ids_equal_the_library(raw, library):
    random.seed(1)
    mixed = ["".join(random.choice(["'", "s", "re", " ", "  ", "\n", "a", "Z", "1", "é", "?", "ll", "\t", "日"]) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    for texts in (ODD, mixed):
        assert encode(raw, texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_table_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blocks = tokens.token_blocks(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {d: x for b in blocks for d, x in tokens.decode_block(b)}
    assert got.keys() == texts.keys()
    for d, x in got.items():
        assert x[-1] == tokens.END and library.decode(x[:-1].tolist()) == texts[d]
        assert x[:-1].tolist() == library.encode_ordinary(texts[d])
    again = {r.doc_id: r.ids for r in tokens.read_tokens(tokens.token_blocks(docs)).collect()}
    assert all(again[d] == x.tolist() for d, x in got.items())
    spans = tokens.spans(tokens.token_blocks(docs)).collect()
    assert {r.doc_id: r.n_ids for r in spans} == {d: len(x) for d, x in got.items()}
    assert sum(r["first"] == 0 for r in spans) == len(blocks)


def test_elias_fano_select():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 5), (3, 3), (100, 7), (500, 10**6), (1000, 1000), (200, 2**33)):
        v = np.sort(rng.integers(0, top + 1, n))
        v[-1] = top
        low, a, b, c = tokens.elias_fano(v, top)
        e = tokens.Ends(n, low, a, b, c)
        assert [e.select(i) for i in range(n)] == v.tolist() == e.all().tolist()
        assert len(a) + len(b) <= n * (2 + max(0, np.log2(max(top, 1) / n))) / 8 + n / 8 + 4


def test_odd_rows(spark, library):
    long = "word " * 300000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "twice", "x"), (4, "twice", "x"), (5, long, "x")]
    out = tokens.token_blocks(spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)).collect()
    got = [(d, library.decode(x[:-1].tolist())) for b in out for d, x in tokens.decode_block(b)]
    assert sorted(got, key=str) == sorted([(d, t or "") for d, t, _ in rows], key=str)
    assert tokens.token_blocks(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabulary_path_is_a_parameter(spark, tmp_path):
    p = tmp_path / "bytes.tiktoken"
    p.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 70000")
    (b,) = tokens.token_blocks(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), str(p), end=256).collect()
    assert b.width == 32 and tokens.decode_block(b)[0][1].tolist() == [70000, 99, 256]
