"""Quality rules, line first: failing lines go, then documents that lost too much text.

Everything is a row-local Spark expression, so there is no shuffle, no Python and no state: a
document of any source or size costs its own length only. Null and empty texts have no words and fail;
null ids, repeated rows and columns with any other names pass through untouched (those called like a result with its
prefix give way to it). An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = "[^ \\t-\\r]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line without closing punctuation fails when it has fewer words than this.
SHORT_LINE_WORDS = 4
#: Symbols, or exclamation marks, in a hundred words from which a line fails.
MAX_SYMBOLS_PERCENT = 50
MAX_SHOUTS_PERCENT = 50
#: Menu separators from which a line counts as navigation, if they also are so many in a hundred words.
NAV_SEPARATORS = 3
NAV_PERCENT = 15
#: A document goes when it lost more than so many in a hundred of the characters in its words.
MAX_LOSS_PERCENT = 30
CLOSING = ".!?:;\"')]\u2026\u201d\u2019\u00bb\u3002\uff01\uff1f"
NAV_HINT = "[|>\\u00bb\\u2022\\u00b7/]|::|->"
NAV_MARKS = "(^|[ \\t])([|>\\u00bb\\u2022\\u00b7/]|::|->)(?=[ \\t]|$)"
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses? cookies|lorem ipsum"
    "|enable javascript|sign up for our newsletter|subscribe to our|click here to|skip to (main )?content"
    "|share this (article|page|post)|read more \\u00bb"
    "|alle rechte vorbehalten|datenschutzerkl\u00e4rung|verwenden cookies|newsletter abonnieren"
    "|tous droits r\u00e9serv\u00e9s|politique de confidentialit\u00e9|utilise des cookies|mentions l\u00e9gales"
    "|todos los derechos reservados|pol\u00edtica de (privacidad|cookies)|utiliza cookies|aviso legal"
)
#: Every match of ``BOILERPLATE`` holds one of these, so a text without any has no such line.
BOILERPLATE_STEMS = (
    "all rights reserved", "terms of ", "privacy policy", "cookie policy", "cookies", "lorem ipsum", "enable javascript",
    "sign up for our newsletter", "subscribe to our", "click here to", "skip to ", "share this ", "read more \u00bb",
    "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "newsletter abonnieren", "tous droits r\u00e9serv\u00e9s", "politique de confidentialit\u00e9",
    "mentions l\u00e9gales", "todos los derechos reservados", "pol\u00edtica de ", "aviso legal",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def may_hold_boilerplate(text: Column) -> Column:
    """Whether boilerplate is worth looking for in the lines of a text; false only if none can match."""
    lowered = F.lower(text)
    return reduce(or_, (F.contains(lowered, F.lit(s)) for s in BOILERPLATE_STEMS))


def line_fails(line: Column, hinted: Column) -> Column:
    """Whether a line goes; lines without a word never do, they carry no text to judge.

    ``hinted``: ``may_hold_boilerplate`` of the line's text.

    Cheap tests stand first: words are counted only in lines that lack a closing mark or hold symbols,
    shouts or separators, which few lines of prose do.
    """
    n = F.size(words(line)).cast("long")
    closed = F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1).isin(*CLOSING)
    symbols, marks = _count(line, SYMBOLS), _count(line, NAV_MARKS)
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    punctuation = (~closed & (n < SHORT_LINE_WORDS)) | ((symbols > 0) & (100 * symbols > MAX_SYMBOLS_PERCENT * n)) | ((shouts > 0) & (100 * shouts > MAX_SHOUTS_PERCENT * n))
    navigation = line.rlike(NAV_HINT) & (marks >= NAV_SEPARATORS) & (100 * marks > NAV_PERCENT * n)
    boilerplate = hinted & F.lower(line).rlike(BOILERPLATE)
    return line.rlike(HAS_WORD) & (punctuation | navigation | boilerplate)


def repeated_words(w: Column, grams: Column) -> Column:
    """Words that some ``WINDOW``-word window covers whose hash occurs twice. ``grams``: the windows' hashes."""
    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(ranked),
        lambda s: F.array_sort(
            F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )[0]
    covered = F.transform(
        F.array(twice),
        lambda p: F.aggregate(
            F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )[0]
    plain = (F.size(w) < WINDOW) | (F.size(F.array_distinct(grams)) == F.size(grams))
    return F.when(plain, F.lit(0)).otherwise(covered).cast("long")


def assess(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Adds ``<prefix>`` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, clean_text (the lines that pass), kept. ``prefix`` keeps them clear of the input's."""
    c = lambda name: F.col(f"{prefix}{name}")
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"{prefix}words": words(F.col(text)), f"{prefix}lines": F.split(body, "\n"), f"{prefix}hinted": may_hold_boilerplate(body)})
    w = c("words")
    grams = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns(
        {
            f"{prefix}grams": grams,
            f"{prefix}full": F.filter(c("lines"), lambda x: x.rlike(HAS_WORD)),
            f"{prefix}fails": F.transform(c("lines"), lambda x: line_fails(x, c("hinted"))),
        }
    )
    out = out.withColumn(f"{prefix}gone", F.filter(c("lines"), lambda x, i: F.get(c("fails"), i)))
    clean = F.when(F.size(c("gone")) == 0, body).otherwise(F.array_join(F.filter(c("lines"), lambda x, i: ~F.get(c("fails"), i)), "\n"))
    lost = F.when(F.size(c("gone")) == 0, F.lit(0)).otherwise(_word_chars(F.array_join(c("gone"), "\n"))).cast("long")
    out = out.withColumns(
        {
            f"{prefix}n_words": F.size(w).cast("long"),
            f"{prefix}word_chars": F.length(F.array_join(w, "")).cast("long"),
            f"{prefix}n_symbols": _count(body, SYMBOLS),
            f"{prefix}n_dup_lines": (F.size(c("full")) - F.size(F.array_distinct(c("full")))).cast("long"),
            f"{prefix}n_repeat_words": repeated_words(w, c("grams")),
            f"{prefix}clean_text": clean,
            f"{prefix}lost": lost,
        }
    )
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    out = out.withColumn(f"{prefix}base_failed", failed)
    out = out.withColumn(f"{prefix}kept", ~c("base_failed") & (100 * c("lost") <= MAX_LOSS_PERCENT * c("word_chars")))
    return out.drop(*(f"{prefix}{x}" for x in ("words", "lines", "hinted", "grams", "full", "fails", "gone", "lost")))


def keep_clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that are kept, with the cleaned text and its length in code points.

    The verdict is tied to a row number that says nothing, which keeps the optimiser from moving the filter below
    the arrays it rests on: there it would build them again for every element that a lambda looks at.
    """
    judged = assess(docs, text).withColumn("_q_stay", F.col("_q_kept") & (F.monotonically_increasing_id() >= 0))
    kept = judged.where("_q_stay").withColumns({text: F.col("_q_clean_text"), length: F.length("_q_clean_text").cast("long")})
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """One row per document: the base counts, whether they fail, and the verdict."""
    from .common import tables

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    clean = F.length("_q_clean_text").cast("long").alias("clean_chars")
    return assess(docs).select("doc_id", *(F.col(f"_q_{x}").alias(x) for x in names), clean)


OP6_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), grams AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), marked AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM marked) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM d
), judged AS (
  SELECT rid, no, line, n,
    n = 0 OR NOT (
      (NOT regexp_matches(rtrim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '),
         '[.!?:;"'')\]\x{2026}\x{201d}\x{2019}\x{bb}\x{3002}\x{ff01}\x{ff1f}]$') AND n < 4)
      OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 50 * n
      OR 100 * len(regexp_extract_all(line, '!')) > 50 * n
      OR (marks >= 3 AND 100 * marks > 15 * n)
      OR regexp_matches(lower(line), '@BOILERPLATE@')
    ) AS ok
  FROM (SELECT rid, no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
      len(list_filter(string_split(translate(line, chr(9), ' '), ' '), lambda x: x IN ('|', '>', '»', '•', '·', '/', '::', '->'))) AS marks FROM lines)
), by_doc AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (ok), '') AS clean
  FROM judged GROUP BY rid
), base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, b.dup::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, b.clean
  FROM w JOIN by_doc b USING (rid) LEFT JOIN covered c USING (rid)
), verdict AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - length(regexp_replace(clean, '[\x20\x09-\x0D]+', '', 'g'))) <= 30 * word_chars AS kept,
  length(clean)::BIGINT AS clean_chars
FROM verdict
""".replace("@BOILERPLATE@", BOILERPLATE.replace("\\u00bb", "\u00bb"))
)
