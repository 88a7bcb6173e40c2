"""Quality rules with cross-document line frequency, with SQL expressions only.

Lines are normalised and hashed, each line's documents are counted per host (the
source column), lines above the limit are removed, and documents that are left with
too few words are rejected.  The base measures are computed in the same scan, inside
one row and without exploding words: a text's three-word windows are hashed, tagged
with their position, sorted as longs, and equal neighbours are repeats.  Neighbours of
equal hashes are compared word by word; where two differ, that text's windows are sorted
as strings instead, so the count is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: A line in more documents of one host than this is boilerplate.
MAX_DOCUMENTS = 20
#: A document needs this many words, and this share of its words, after removal.
MIN_WORDS, MIN_SHARE = 50, 0.3

#: The hash of the three-word window at i.
WINDOW_HASH = "xxhash64(get(ws, i), get(ws, i + 1), get(ws, i + 2))"

WS = r"[\\x20\\x09-\\x0D]"


def _measured(docs: DataFrame) -> DataFrame:
    """One row per row: base measures, host, text, and (hash, words) of each line."""
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = rows.withColumns({"ws": F.expr(f"array_remove(split(t, '{WS}+'), '')"), "ls": F.expr(f"filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")})
    rows = rows.withColumns({"n": F.expr("coalesce(size(ws), 0)"), "nb": F.expr("coalesce(64 - length(bin(greatest(size(ws), 1))) , 0)")})
    # positions take the low bits that the number of words needs, the hash the others
    rows = rows.withColumn("nb", F.expr("64 - nb"))
    tagged = f"CASE WHEN n >= 3 THEN transform(sequence(0, greatest(n - 3, 0)), i -> coalesce(shiftleft(shiftright({WINDOW_HASH}, nb), nb) + i, 0L)) ELSE cast(array() as array<bigint>) END"
    rows = rows.withColumn("tagged", F.expr(f"sort_array({tagged})"))
    place = lambda x: f"cast({x} - shiftleft(shiftright({x}, nb), nb) as int)"
    same = "shiftright(x, nb) = shiftright(get(tagged, k {} 1), nb)"
    differ = " OR ".join(f"get(ws, {place('x')} + {j}) <> get(ws, {place('get(tagged, k - 1)')} + {j})" for j in range(3))
    rows = rows.withColumn("clash", F.expr(f"size(filter(tagged, (x, k) -> k > 0 AND {same.format('-')} AND ({differ}))) > 0"))
    twice = f"transform(filter(tagged, (x, k) -> coalesce({same.format('+')}, false) OR (k > 0 AND {same.format('-')})), x -> coalesce(x - shiftleft(shiftright(x, nb), nb), 0L))"
    strings = "array_sort(transform(sequence(0, greatest(n - 3, 0)), i -> named_struct('s', concat_ws(' ', get(ws, i), get(ws, i + 1), get(ws, i + 2)), 'i', i)))"
    equal = f"aggregate({strings}, named_struct('s', cast(null as string), 'i', -1, 'all', cast(array() as array<bigint>)), (a, x) -> named_struct('s', x.s, 'i', x.i, 'all', CASE WHEN a.s = x.s THEN array_union(a.all, array(cast(a.i as bigint), cast(x.i as bigint))) ELSE a.all END), a -> a.all)"
    rows = rows.withColumn("again", F.expr(f"sort_array(CASE WHEN clash THEN {equal} ELSE {twice} END)"))
    covered = "aggregate(again, named_struct('last', -3L, 'all', 0L), (a, x) -> named_struct('last', x, 'all', a.all + least(3L, x - a.last)), a -> a.all)"
    line = f"named_struct('h', xxhash64(trim(regexp_replace(lower(x), '{WS}+', ' '))), 'w', cast(size(array_remove(split(x, '{WS}+'), '')) as int))"
    return rows.select(
        "doc_id",
        "host",
        F.col("n").cast("bigint").alias("n_words"),
        F.expr("cast(length(translate(t, ' \\t\\n\\u000B\\u000C\\r', '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(ls) - size(array_distinct(ls)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast({covered} as bigint)").alias("n_repeat_words"),
        F.expr(f"transform(split(t, '\\n'), x -> {line})").alias("lines"),
        F.col("t").alias("text"),
    )


def line_frequency_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, texts: bool = True) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``n_words_left``, ``kept`` and ``text_left`` of every row.

    ``text_left`` is the text without its frequent lines, rejected rows' too, and
    ``n_words_left`` counts its words; lines without a word stay.  Where the texts are not
    wanted, ``texts=False`` leaves that column out, and they are not written between the steps.

    A line is its words in lower case with single blanks; lines without a word are
    not counted.  Each row is a document, repeated rows and repeated doc_ids
    included, so many copies in one host do make their lines frequent.  A null source
    is one host.  Null and empty texts have no words and fail the base rule.  A null
    doc_id keeps its row.  An empty table gives no rows, and other columns are not
    read.
    """
    measured = _measured(docs) if texts else _measured(docs).drop("text")
    base = materialize(measured.withColumn("rid", F.monotonically_increasing_id()), "rules")
    lines = base.select("rid", "host", F.explode(F.expr("array_distinct(transform(filter(lines, x -> x.w > 0), x -> x.h))")).alias("h"))
    often = materialize(lines.groupBy("host", "h").count().where(F.col("count") > max_documents).select("host", "h"), "often")
    gone = lines.join(often, ["host", "h"]).groupBy("rid").agg(F.collect_list("h").alias("gone"))  # distinct in a row
    left = base.drop("host").join(materialize(gone, "gone"), "rid", "left")
    lost = "aggregate(filter(lines, x -> array_contains(gone, x.h)), 0L, (a, x) -> a + x.w)"
    left = left.withColumn("n_words_left", F.expr(f"CASE WHEN gone IS NULL THEN n_words ELSE n_words - {lost} END"))
    if texts:
        stays = "filter(split(text, '\\n'), (x, i) -> lines[i].w = 0 OR NOT array_contains(gone, lines[i].h))"
        left = left.withColumn("text_left", F.expr(f"CASE WHEN gone IS NULL THEN text ELSE array_join({stays}, '\n') END"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = (F.col("n_words_left") >= min_words) & (F.col("n_words_left") >= F.lit(min_share) * F.col("n_words"))
    return left.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_words_left", (~failed & enough).alias("kept"), *(["text_left"] if texts else []))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '-') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), pos AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos
), rep AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY rid
), l AS (
  SELECT rid, host, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d
), n AS (
  SELECT rid, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS lw FROM l
), often AS (
  SELECT host, norm FROM n GROUP BY host, norm HAVING count(DISTINCT rid) > 20
), gone AS (
  SELECT rid, sum(lw) AS gone FROM n JOIN often USING (host, norm) GROUP BY rid
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ws) - coalesce(gone, 0) AS BIGINT) AS n_words_left
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left,
  NOT base_failed AND n_words_left >= 50 AND n_words_left >= 0.3 * n_words AS kept FROM f
""".strip()
