"""The functions in Java against patterns, on odd texts."""

import math
import random
import re

from pyspark.sql import functions as F

from lexforge.functions import text as T

SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
LINE = "[^\n\r\u2028\u2029]"
COMMENT = re.compile(f"//{LINE}*|/\\*(?s:.*?)\\*/")
LITERAL = re.compile("|".join(f"{q}(?:[^{q}\\\\]|\\\\{LINE})*{q}" for q in "\"'`"))
LEXEME = re.compile(f"(?s)(?:[\r\n \t]|\\.\\.\\.|(?:{'|'.join(T.KEYWORDS)})(?a:\\b)|[0-9]+\\.?[0-9]*(?:[eE][+-]?[0-9]+)?(?:n(?a:\\b))?|[A-Za-z_$#][A-Za-z0-9_$\x80-\U0010ffff]*|.)")


def units(x):
    return len(x.encode("utf-16-le")) // 2


def weight(t):
    if t in (" ", "\n", "\r", "\t"):
        return 1
    if t == "...":
        return 2
    if t in T.KEYWORDS:
        return 2 if len(t) <= 5 else 3
    if t[0] in "0123456789":
        return 2 if len(t) <= 4 else 3
    if re.match("[A-Za-z_$#]", t):
        return math.ceil(units(t) / 3.2)
    return {1: 1, 2: 2, 3: 3, 4: 8}[len(t.encode())]


def costs(pattern, x):
    return sum(max(1, math.ceil(units(m.group()) / 3.5)) for m in pattern.finditer(x))


def expected(x):
    tokens = max(1, math.ceil(sum(weight(m.group()) for m in LEXEME.finditer(x)) * 0.88)) if x else 0
    return tokens, units(x), len(re.findall(f"[^{SPACES}]+", x)), costs(COMMENT, x), costs(LITERAL, x)


def test_figures_are_those_of_the_patterns(spark):
    parts = ["for", "as", "instanceof", "é", "$", "#", "_", "1", "12.5e+7", "3n", "n", "e", ".", "...", "..", "/", "//", "/*", "*/", '"', "'", "`", "\\", "\n", "\r", "\u2028", " ", "\u00a0", "\ufeff", "\u3000", "\x1c", "😀", "ä", "日", "Zz", "x", "-", "\0"]
    rng = random.Random(3)
    texts = ["", "for", "foré", "for$ x", "1e5n", "'" + "a" * 200_000 + "'", "'" * 3 + "\\'" * 50_000, "/*" * 50_000] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = df.select("i", *[c.alias(n) for n, c in T.breakdown(F.col("x")).items()])
    for r in got.collect():
        assert (r.tokens, r.characters, r.words, r.comment_tokens, r.string_tokens) == expected(texts[r.i]), texts[r.i][:99]


def test_null_stays_as_it_was(spark):
    r = spark.createDataFrame([(None,)], "x string").select(*[c.alias(n) for n, c in T.breakdown(F.col("x")).items()]).first()
    assert (r.tokens, r.characters, r.words, r.comment_tokens, r.string_tokens) == (1, None, None, None, None)


def test_figures_as_json_of_a_long_literal(spark):
    import json

    x = '"' + "b" * 100_000 + '" // c'
    r = spark.createDataFrame([(x,)], "x string").select(F.to_json(F.struct(*[c.alias(n) for n, c in T.breakdown(F.col("x")).items()])).alias("j")).first()
    assert json.loads(r.j)["string_tokens"] == expected(x)[4] and json.loads(r.j)["comment_tokens"] == 2
