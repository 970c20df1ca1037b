"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row of RULES: a measure, its bounds and the number of words from which it holds. The measures are ratios of
counts that built-in expressions take from the text, so the whole table becomes one projection and one filter; nothing is
shuffled and no user function runs.

Defined results: a null text counts as empty; an empty or blank text has 0 words and is rejected by the word count; rows that
repeat are judged alike; a null doc_id passes through; other columns pass through, and measures whose names clash with them are
only internal. An empty table gives an empty result. Texts of any length are measured whole.

The share of distinct words falls as any text grows. In a text of more than WINDOW words it is therefore the mean over windows of
WINDOW words that follow each other to the text's end, each weighing as many words as it has. Such a text that says the same again
at a distance passes in every window; so the measure is at most the share of distinct runs of RUN words in the whole text, which
doesn't fall with length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the and of to a in is that it was for on with as be by are this at from or an not but have he his they "
    "de la que el en las y los se del un no con por para una su es al lo "
    "et le les des du une est qui dans par sur pas avec au pour "
    "der die und den von das zu mit sich für nicht auf ist dem im ein eine als"
).split()

#: measure, least, most, words from which the rule holds
RULES: list[tuple[str, float | None, float | None, int]] = [
    ("n_words", 1, None, 0),
    ("mean_word_chars", 2.0, 12.0, 20),
    ("symbol_ratio", None, 0.1, 1),
    ("upper_ratio", None, 0.4, 10),
    ("alpha_word_ratio", 0.6, None, 10),
    ("stop_word_ratio", 0.1, None, 40),
    ("distinct_word_ratio", 0.2, None, 40),
    ("duplicate_line_ratio", None, 0.35, 10),
    ("bar_line_ratio", None, 0.5, 10),
]
RULES_BY_NAME = {r[0]: r for r in RULES}
#: The rules as the SQL states them. It bounds the words and has no windows, so it agrees with RULES on texts of up to WINDOW words.
SQL_RULES = [("n_words", 1, 200_000, 0), *RULES[1:]]
#: Words of a window, and of a run that is counted once in a text of several windows.
WINDOW, RUN = 1 << 15, 8

_BLANK = " \\t\\n\\r\\f"
_SIGNS = ".,;:!?'\"()-"
#: Signs that words lose.
_ENDS = ".,;:!?"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _distinct_words(words: Column, n: Column) -> Column:
    """Distinct words of each window, summed; no more than the distinct runs in a text of several windows."""
    windows = F.sequence(F.lit(0), ((n - 1) / WINDOW).cast("int"))
    by_window = F.aggregate(windows, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(words, i * WINDOW + 1, WINDOW))))
    runs = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(RUN)]))
    return F.when(n > WINDOW, F.least(by_window, F.size(F.array_distinct(runs)))).otherwise(F.size(F.array_distinct(words)))


def measures(text: Column) -> list[dict[str, Column]]:
    """Expressions by name in layers, each of which may use the names of the layers before it."""
    c = F.col
    return [
        {"_t": F.coalesce(text, F.lit(""))},
        {
            "_words": F.filter(F.split(F.translate(F.lower("_t"), _ENDS, ""), f"[{_BLANK}]+"), lambda w: w != ""),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: F.trim(x) != ""),
            "_plain": F.regexp_replace("_t", f"[^\\p{{L}}{_BLANK}]+", ""),
            "_digits": F.length(F.regexp_replace("_t", "[^\\p{N}\\p{M}]+", "")),
            "_signs": F.length("_t") - F.length(F.translate("_t", _SIGNS, "")),
            "_bars": F.size(F.filter(F.split("_t", "\n"), lambda x: x.contains("|"))),
            "n_chars_seen": F.length("_t"),
        },
        {
            "n_words": F.size("_words"),
            "n_lines": F.size("_lines"),
            "_blank": F.length("_plain") - F.length(F.translate("_plain", " \t\n\r\f", "")),
            "_upper": F.length(F.regexp_replace("_plain", "[^\\p{Lu}]+", "")),
            "_alpha_words": F.regexp_count("_plain", F.lit(f"[^{_BLANK}]+")),
            "_letters": F.length("_plain"),
        },
        {
            "mean_word_chars": _ratio(c("n_chars_seen") - c("_blank"), c("n_words")),
            "symbol_ratio": _ratio(c("n_chars_seen") - c("_letters") - c("_digits") - c("_signs"), c("n_chars_seen")),
            "upper_ratio": _ratio(c("_upper"), c("_letters") - c("_blank")),
            "alpha_word_ratio": _ratio(c("_alpha_words"), c("n_words")),
            "stop_word_ratio": _ratio(F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))), c("n_words")),
            "distinct_word_ratio": _ratio(_distinct_words(c("_words"), c("n_words")), c("n_words")),
            "duplicate_line_ratio": _ratio(c("n_lines") - F.size(F.array_distinct("_lines")), c("n_lines")),
            "bar_line_ratio": _ratio(c("_bars"), c("n_lines")),
        },
    ]


def verdict(rules=None) -> Column:
    """True for a row whose measures are all within bounds."""
    ok = F.lit(True)
    for name, least, most, words in rules or RULES:
        fits = F.lit(True)
        if least is not None:
            fits &= F.col(f"m.{name}") >= F.lit(least)
        if most is not None:
            fits &= F.col(f"m.{name}") <= F.lit(most)
        ok &= (F.col("m.n_words") < words) | fits
    return ok


def measured(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """Struct `_doc` of the given columns, struct `m` of the measures, and `keep`. The measures leave a generator of one row,
    through which no filter is pushed: pushed down, it would hold every expression again, once for each use."""
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    layers = measures(F.col(f"_doc.`{text}`"))
    for layer in layers[:-1]:
        df = df.withColumns(layer)
    m = F.struct("n_words", *[e.alias(n) for n, e in layers[-1].items()])
    return df.select("_doc", F.explode(F.array(m)).alias("m")).select("_doc", "m", verdict(rules).alias("keep"))


def quality_filter(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    return measured(docs, text, rules).filter("keep").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


SHOWN = [r[0] for r in RULES]


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=None) -> DataFrame:
    """doc_id and rounded measures of each row that is kept."""
    kept = measured(docs.select(doc_id, text), text, rules).filter("keep")
    return kept.select(F.col(f"_doc.`{doc_id}`").alias("doc_id"), F.col("m.n_words").cast("long").alias("n_words"), *[F.round(f"m.{n}", 6).alias(n) for n in SHOWN if n != "n_words"])


def oracle_sql(rules=None) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = "[ \\t\\n\\r\\f]"
    rule = " AND ".join(
        f"(n_words < {words} OR ({' AND '.join(x for x in (f'{n} >= {lo}' if lo is not None else '', f'{n} <= {hi}' if hi is not None else '') if x)}))"
        for n, lo, hi, words in rules or SQL_RULES
    )
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END"
    shown = ", ".join("n_words::BIGINT AS n_words" if n == "n_words" else f"round({n}, 6) AS {n}" for n in SHOWN)
    signs = _SIGNS.replace("'", "''")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, length(t) AS nc,
  list_filter(regexp_split_to_array(translate(lower(t), '{_ENDS}', ''), '{blank}+'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS lines,
  length(t) - length(regexp_replace(t, '{blank}', '', 'g')) AS blank,
  length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(t, '[^\\p{{N}}\\p{{M}}]', '', 'g')) AS digits,
  length(t) - length(translate(t, '{signs}', '')) AS signs,
  length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS upper,
  len(list_filter(regexp_split_to_array(t, '{blank}+'), lambda w: regexp_matches(w, '\\p{{L}}'))) AS alpha FROM t),
b AS (SELECT *, len(words) AS n_words, len(lines) AS n_lines FROM a),
c AS (SELECT doc_id, n_words,
  {r("nc - blank", "n_words")} AS mean_word_chars,
  {r("nc - blank - letters - digits - signs", "nc")} AS symbol_ratio,
  {r("upper", "letters")} AS upper_ratio,
  {r("alpha", "n_words")} AS alpha_word_ratio,
  {r(f"len(list_filter(words, lambda w: w IN ({stop})))", "n_words")} AS stop_word_ratio,
  {r("len(list_distinct(words))", "n_words")} AS distinct_word_ratio,
  {r("n_lines - len(list_distinct(lines))", "n_lines")} AS duplicate_line_ratio,
  {r("len(list_filter(lines, lambda x: contains(x, '|')))", "n_lines")} AS bar_line_ratio FROM b)
SELECT doc_id, {shown} FROM c WHERE {rule}"""
